"""Texts of known licences and the notices that stand for one. Public texts; copyright lines are left out on comparison."""

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.\n"
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission.\n"
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
    "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_TAIL = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
    "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_MIT = f"{_GRANT}, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n{_AS_IS}"

#: (licence id, whole text)
TEXTS = [
    ("MIT", _MIT),
    ("MIT", f"MIT License\n{_MIT}"),
    ("MIT", f"The MIT License (MIT)\n{_MIT}"),
    ("MIT-0", f"{_GRANT}.\n{_AS_IS}"),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("ISC", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_TAIL}"),
    ("ISC", f"ISC License\n{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_TAIL}"),
    ("0BSD", f"{_ISC}.\n{_ISC_TAIL}"),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
        "from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must "
        "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
        "software.\n3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a '
        "copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed "
        'under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for '
        "the specific language governing permissions and limitations under the License.",
    ),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any later version.\nThis program is distributed in the hope that it will be "
        "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General "
        "Public License for more details.\nYou should have received a copy of the GNU General Public License along with this program. If not, see "
        "<https://www.gnu.org/licenses/>.",
    ),
]

_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n"
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
    "purpose, commercial or non-commercial, and by any means.\n"
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the "
    "public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication "
    "to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
    "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n"
    "For more information, please refer to <http://unlicense.org"
)
_BOOST = (
    "Boost Software License - Version 1.0 - August 17th, 2003\n"
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this "
    'license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to '
    "permit third-parties to whom the Software is furnished to do so, all subject to the following:\n"
    "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be "
    "included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in "
    "the form of machine-executable object code generated by a source language processor.\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS '
    "FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR "
    "OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
TEXTS += [("Unlicense", f"{_UNLICENSE}>"), ("Unlicense", f"{_UNLICENSE}/>"), ("BSL-1.0", _BOOST)]

#: (licence id, notice): a line that says this and no more names the licence.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "Released under CC0 1.0."),
]

#: (characters, those that stand for them), replaced in this order in lower-case text
MARKS = [("&", " and "), ("https://", "http://"), ("\u00ad", "")]
#: (spelling, the one that stands for it): whole words, replaced in this order
SPELLINGS = [
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("acknowledgements", "acknowledgments"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("copy right", "copyright"),
    ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"),
    ("emphasise", "emphasize"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("honour", "honor"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("merchantibility", "merchantability"),
    ("modelling", "modeling"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
]

#: (licence id, canonical digest) of longer licences: whole, and up to their end of terms, without and with that line.
DIGESTS = [
    ("Apache-2.0", "2e395a8c89bc57e58e61b5f397a762ee419e61392201c30407f9347a02bfe64f"),
    ("Apache-2.0", "eb47abbfd4ee0aac82780ff3c3eb13764568c300ff8ff46dbe0a67629fdb6289"),
    ("Apache-2.0", "416d4a6acf40abac0d9fa18d09e28e47b226da55dc44df53ca3ea2ca49392a50"),
    ("Artistic-1.0-Perl", "b4afa077d253371bcb30944c7a16b4385d4d6a3a4220363535165a4734387bae"),
    ("BSD-3-Clause", "d0a339eb5454123c6a1f2696aace557e0561866f3fe33b93ffad58ecfcab7060"),
    ("CC0-1.0", "adf75bc38a3fbbdcbadda90b262623acbb176db40d4de0538e4bddaa4c7f8d2a"),
    ("GFDL-1.2", "79f84c30eb127b035e2c79de87c19f6f5fa93914894a6d6ea6056bda9195dfe3"),
    ("GFDL-1.3", "743c2fcd972b3b2f3053868c5341a2d8984151e4843d52f24de38ac106b4b653"),
    ("GPL-1.0", "dcaed0a1339d5df23af0df7988f9a4094490f7be57bf99e7ade811de3351656d"),
    ("GPL-1.0", "966bfc5decc8a85ba25425362605c0e9e2472dc48a0cd9cd2aa678077a1798b2"),
    ("GPL-1.0", "e7d0184665046b7b6606aab95cb6321a497aa126fb7c18b302fd1efb9312e27f"),
    ("GPL-2.0", "29c781c1bb5cfa33259c972f7a5d81accdc4c6749b6edd46b1773fb2be0c2c3e"),
    ("GPL-2.0", "fd7f243bc45d702548bcd1d299b89a348fab6a0fc0c9d51c29579e068f30ef15"),
    ("GPL-2.0", "6e9f5379fb7ac3f4152d736ab379fb0771e25eedbc4cead5966bce1f6cb65366"),
    ("GPL-3.0", "5045869c661ae395ec11f0447de8eecbab23b8642bb24a9024a1b54c1b9ca98e"),
    ("GPL-3.0", "e3e00bdb750b297b609d3f9399db7c5ad50f690a3ab84e9a36a47e7ac6ccc391"),
    ("GPL-3.0", "1f97962d8e053707fa81cbe46ba99208ee6a432a1878949a6e53c53ea84b92a0"),
    ("LGPL-2.0", "41e812bc7f7e722920e0118340d2470ee1009174cbf9f2baa962556c286575ed"),
    ("LGPL-2.0", "39e848f33423e685b79853ff7103e1eccae9adefaa3ca7010205db81644f1cda"),
    ("LGPL-2.0", "66849d83aff839fcf244074fbddaa3c5722fb679c72f20e6faa827c08a64c947"),
    ("LGPL-2.1", "7e125e82dd44641085c9a5d4eef7e13ed3262cc816b38d8318eed4a5fe112fbb"),
    ("LGPL-2.1", "31f6f022f29aa8fd976b7eede993f73a648983b52a7c2b5b2b168fad0d01089c"),
    ("LGPL-2.1", "1a0a1112b88b9898ddf983e67cd138cc7a3d4cbb03867db7cfd72c91f8fa9a66"),
    ("LGPL-3.0", "828c3944cde1fc14c68737c9be14d8d0f4f13ab980f8a72364a0e64f72965525"),
    ("MPL-1.1", "3f91a6d3cc2d2838ffd49bb7f76001d91a192ddae78af59f067ed8b1845c3cf7"),
    ("MPL-2.0", "cf0cbde7aa46b215c9fa1eda48a097d574d70a04e3c2fab1c0b55f755160d0d6"),
]
